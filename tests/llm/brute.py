"""Plain versions of the contracts, for comparison on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near(docs, percent=85, size=3):
    """docs: (id, text) with distinct ids. {id: (n, component, kept)}"""
    sets = {}
    for i, t in docs:
        w = words((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def leaks(docs, items, length=10):
    """{doc id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(length, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = sorted({len(x) for x in windows})
    out = {}
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def quality_base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed


def secret_base(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{i}:{j}" for i, k, j in sorted(out))
    return tuple(sum(k == x for _, x, _ in out) for k in range(3)) + (sha(joined),)


_tokenizer = None


def token_pieces(text, size=2048):
    """(start, length, crc32) of each piece."""
    global _tokenizer
    if _tokenizer is None:
        import public_tokenizers
        from tokenizers import Tokenizer

        _tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = _tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
    return [(a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for a, b in zip(cuts, cuts[1:])]


def toxicity(docs, labels, o):
    """{id: (score, evidence)} from all terms as strings; for ASCII texts without near copies. o: the operator's constants."""
    import math

    import xxhash

    def terms(text):
        own, total = Counter(re.findall("[a-z]+", (text or "").lower())), 0
        total = sum(own.values())
        out = Counter(own)
        for size in o.STEMS:
            stems = Counter()
            for w, n in own.items():
                if len(w) > size:
                    stems[w[:size] + f"*{size}"] += n
            out.update(stems)
        for t, n in list(out.items()):
            out.update({f"{t}%{p}": 1 for p in o.DENSE if n > 1 and 100 * n >= p * total})
        return out

    text_of, known = dict(docs), {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    signed = lambda t: (lambda v: v - (v >> 63 << 64))(xxhash.xxh64_intdigest(t.encode(), seed=42))
    by_hash = {}
    for i in sorted(known, reverse=True):
        if text_of[i]:
            by_hash[signed(text_of[i])] = i
    ids = [i for _, i in sorted(by_hash.items())]
    y = [known[i] for i in ids]
    counts = [terms(text_of[i]) for i in ids]
    n1, n0 = sum(y), len(y) - sum(y)
    telling = set()
    for t in set().union(*counts):
        a, b = (sum(t in c for c, k in zip(counts, y) if k == v) for v in (1, 0))
        p, q, m = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (a + b + 1) / (n1 + n0 + 2)
        z = abs(p - q) / math.sqrt(m * (1 - m) * (1 / n1 + 1 / n0))
        if a + b >= o.MIN_DOCS and z >= o.Z and max(p / q, q / p) >= o.RATIO:
            telling.add(t)
    words = {t for c in counts for t in c if t.isalpha()} | telling
    df = Counter(t for _, text in docs for t in terms(text) if t in words)

    def vector(c):
        v = {}
        for t, n in c.items():
            if t in words:
                idf = math.log((1 + len(docs)) / (1 + df[t]))
                w = o.BOOST * (idf + 1) if t in telling else max(0.0, idf - math.log(o.COMMON))
                if w:
                    v[t] = (1 + math.log(n)) * w
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    vectors, rate = [vector(c) for c in counts], sum(y) / len(y)

    def near(v, without=-1):
        s = sorted((-round(sum(w * u.get(t, 0) for t, w in v.items()), 12), e) for e, u in enumerate(vectors) if e != without)
        return [(-a, e) for a, e in s[: o.K] if a < 0]

    vote = lambda n: (sum(s * y[e] for s, e in n) + o.PRIOR * rate) / (sum(s for s, _ in n) + o.PRIOR)
    found = [near(v, e) for e, v in enumerate(vectors)]
    none = [y[e] for e, n in enumerate(found) if not n]
    bare = (sum(none) + rate) / (len(none) + 1)
    pools = [[v, v, t, 1] for v, t in sorted((vote(n), y[e]) for e, n in enumerate(found) if n)]
    k = 0
    while k + 1 < len(pools):
        if pools[k][2] / pools[k][3] >= pools[k + 1][2] / pools[k + 1][3]:
            pools[k : k + 2] = [[pools[k][0], pools[k + 1][1], pools[k][2] + pools[k + 1][2], pools[k][3] + pools[k + 1][3]]]
            k = max(0, k - 1)
        else:
            k += 1
    xs, ys = zip(*((x, (t + rate) / (n + 1)) for a, b, t, n in pools for x in (a, b)))

    def curve(v):
        if v <= xs[0]:
            return ys[0]
        for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
            if v <= x1:
                return y1 if x1 == x0 else y0 + (y1 - y0) * (v - x0) / (x1 - x0)
        return ys[-1]

    out = {}
    for i, t in docs:
        n = near(vector(terms(t)))
        out[i] = (min(1.0, max(0.0, curve(vote(n)))) if n else bare, [str(ids[e]) for _, e in n])
    return out


def url_tree(urls, o):
    """urls: (host, path, verdict or None), each once with its number. {(host, path): (template, purity, labels)} by a plain tree. o: the operator's constants."""
    import math  # noqa: F401

    def shape(s):
        m = re.fullmatch(r"(.*?)(\.[A-Za-z]{1,5})?", s)
        stem, ext = m[1], m[2] or ""
        kind = "" if not stem else "{n}" if re.fullmatch("[0-9]+", stem) else "{hex}" if re.fullmatch("[0-9a-fA-F]{8,}", stem) else "{word}" if not re.search("[0-9]", stem) else "{mix}"
        return kind + ext

    rows = defaultdict(lambda: [0, 0, 0])
    for host, path, verdict in urls:
        r = rows[host, path]
        r[0] += 1
        r[1] += verdict is not None
        r[2] += verdict == "block"
    smooth = lambda b, n, rate: (b + o.PRIOR * rate) / (n + o.PRIOR)
    total = lambda own: [sum(rows[k][i] for k in own) for i in range(3)]
    out = {}

    def descend(own, node, level, rate):
        if not total(own)[1]:  # no label can change a verdict below
            for host, path in own:
                out[host, path] = (node + "/**" if level < len(path.split("/")[1:]) else node, rate)
            return
        going = defaultdict(list)
        for host, path in own:
            parts = path.split("/")[1:]
            if level < len(parts):
                going[parts[level]].append((host, path))
            else:
                out[host, path] = (node, rate)
        size = sum(total(v)[0] for v in going.values())
        stays = {s for s, v in going.items() if total(v)[0] >= o.MIN_COUNT and total(v)[0] >= o.SHARE * size}
        alike = defaultdict(list)
        for s in going:
            if s not in stays:
                alike[shape(s)].append(s)
        parts = defaultdict(list)
        for s, v in going.items():
            if s in stays:
                parts[s].append(s)
                continue
            kin = alike[shape(s)]
            n, b = total(v)[1:]
            told = sum(total(going[k])[1] > 0 for k in kin)
            everyone = [sum(x) for x in zip(*(total(going[k]) for k in kin))]
            rest, blocked = everyone[1] - n, everyone[2] - b
            side = ""
            if n == 0 and everyone[1] > 0 and not (told >= o.MIN_LABELS and everyone[1] >= o.COVER * everyone[0]):
                side = "?"
            elif n and rest:
                pooled, gap = everyone[2] / everyone[1], b / n - blocked / rest
                if gap * gap / max(pooled * (1 - pooled) * (1 / n + 1 / rest), 1e-9) >= o.MERGE:
                    side = "+" if gap > 0 else "-"
            parts[shape(s) + side].append(s)
        for part, segments in parts.items():
            below = [k for s in segments for k in going[s]]
            descend(below, f"{node}/{part}", level + 1, smooth(total(below)[2], total(below)[1], rate))

    for host in {h for h, _ in rows}:
        own = [k for k in rows if k[0] == host]
        descend(own, host, 0, smooth(total(own)[2], total(own)[1], 0.5))
    labels = Counter()
    for k, (node, _) in out.items():
        labels[node] += rows[k][1]
    return {k: (node, round(rate, 9), labels[node]) for k, (node, rate) in out.items()}


def quality_rules(docs, min_docs, share, keep, min_words=20):
    """docs: (id, text, source) with distinct ids. {id: text without lines above the limits} of those that pass."""
    alike = lambda line: " ".join(words(re.sub("[0-9]", "0", line.translate(LOW))))
    has = defaultdict(set)
    hosts = Counter(s for _, _, s in docs)
    for i, t, s in docs:
        for line in (t or "").split("\n"):
            if words(line):
                has[s, alike(line)].add(i)
    out = {}
    for i, t, s in docs:
        if quality_base(t)[5]:
            continue
        left, lines = "", t.split("\n")
        for k, line in enumerate(lines):
            own = has.get((s, alike(line)), set()) if words(line) else set()
            if not (len(own) >= min_docs and len(own) >= share * hosts[s] and i != min(own)):
                left += line + ("\n" if k + 1 < len(lines) else "")
        if len(words(left)) >= min_words and len(words(left)) >= keep * len(words(t)):
            out[i] = left
    return out
