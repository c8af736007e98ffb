"""Plain statements of what the operators must find, for small inputs."""

import collections
import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def dedup_lines(docs, min_chars=20, min_docs=3):
    where = collections.defaultdict(set)
    key = lambda line: fold(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                where[key(line)].add(i)
    gone = {k: max(v) for k, v in where.items() if len(v) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or i is None or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Water-filling by rounds: {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def simhash(text, n=3):
    w = words(fold(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(docs, radius=3):
    """{row number: least id reachable}."""
    fp = [simhash(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return fp, [least.get(root(i)) for i in range(len(docs))]


def contaminated(docs, items, n=5, threshold=0.8):
    """{(id, item): (similarity, first word)} over windows of the item's length."""
    bag = lambda w: collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    weight = lambda s: sum(len(x.encode()) for x in s)
    out = {}
    for item, text in items:
        w = words(fold(text))
        if len(w) < n:
            continue
        own = bag(w)
        size = sum(c * weight(s) for s, c in own.items())
        for d, t in docs:
            v, best = words(fold(t)), (0.0, 0)
            for a in range(max(1, len(v) - len(w) + 1)):
                other = bag(v[a : a + len(w)])
                common = sum(min(c, own[s]) * weight(s) for s, c in other.items() if s in own)
                sim = common / (size + sum(c * weight(s) for s, c in other.items()) - common) if common else 0.0
                if sim > best[0]:
                    best = (sim, a)
            if best[0] >= threshold:
                out[d, item] = (round(best[0], 9), best[1])
    return out


def tree_paths(rows, per_tree=3):
    """{(tree, rank): [(node, role, text)]} of rows (tree, node, parent, score, role, text)."""
    first = {}
    for tree, node, parent, score, role, text in rows:
        key = (parent is not None, parent or 0, -(score or 0.0), role or "", text or "")
        if node is not None and ((tree, node) not in first or key < first[tree, node][0]):
            first[tree, node] = (key, parent, score or 0.0, role or "", text or "")
    parent = {k: v[1] if v[1] != k[1] and (k[0], v[1]) in first else None for k, v in first.items()}
    out = {}
    for tree in {k[0] for k in first}:
        nodes = [n for t, n in first if t == tree]
        replied = {parent[tree, n] for n in nodes}
        paths = []
        for n in nodes:
            path = [n]
            while parent[tree, path[-1]] is not None and len(path) <= len(nodes):
                path.append(parent[tree, path[-1]])
            if n not in replied and len(path) <= len(nodes):
                paths.append((-sum(first[tree, x][2] for x in path), n, path[::-1]))
        for rank, (_, _, path) in enumerate(sorted(paths)[:per_tree], 1):
            out[tree, rank] = [(x, *first[tree, x][3:]) for x in path]
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    def ok(kind, match):
        d = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(x) <= 255 for x in match.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
            return 16 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text or "") if ok(k, m[0]))


def pii_graph(docs, support=5, confident=0.8, smooth=0.5, rounds=3):
    """The spans beyond the base: {row: {(kind, start, end)}} of rows (id, text)."""
    ws, kinds = " \t\n\x0b\x0c\r", list(PII)
    secret = re.compile("(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})")

    def patterns(before, after):
        name = lambda w: hashlib.md5(w.encode()).hexdigest() if len(w) > 64 else w.lower()
        left, right = ([name(w) for w in WORD.findall(x)] for x in (before, after))
        out = {f"L {left[-2]} {left[-1]}"} if len(left) > 1 else set()
        out |= {f"O {left[-1]}"} if left else set()
        return out | ({f"B {left[-1]} {right[0]}"} if left and right else set())

    def beside(found, i, text):
        return text[found[i - 1][1] if i else 0 : found[i][0]], text[found[i][1] : found[i + 1][0] if i + 1 < len(found) else len(text)]

    seeds, tokens = set(), []
    for row, (_, text) in enumerate(docs):
        text, good = text or "", {tuple(s.split(":")) for s in pii(text).split(",") if s}
        for k, kind in enumerate(kinds):
            found = [m.span() for m in re.finditer(PII[kind], text)]
            for i, (a, b) in enumerate(found):
                if (kind, str(a), str(b)) in good:
                    seeds |= {(p, k, text[a:b].lower()) for p in patterns(*beside(found, i, text))}
        found = [m.span() for m in WORD.finditer(text) if "@" in m[0] or len(re.findall("[0-9]", m[0])) >= 4]
        for i, (a, b) in enumerate(found):
            if any(int(x) < b and int(y) > a for _, x, y in good):
                continue
            word = text[a:b]
            core = word
            while core and not core[0].isalnum() and core[0] != "+":
                core, a = core[1:], a + 1
            while core and not core[-1].isalnum():
                core = core[:-1]
            hexa = bool(secret.fullmatch(core) and re.search("[0-9]", core) and re.search("[a-fA-F]", core))
            own = patterns(*beside(found, i, text))
            if core:
                tokens.append((row, a, core, hexa, own))
                seeds |= {(p, len(kinds), core.lower()) for p in own} if hexa else set()
    count = collections.Counter((p, k) for p, k, _ in seeds)
    strong = {pk: n for pk, n in count.items() if n >= support}
    names = {p for p, _ in strong}
    unknown = {(p, core.lower()) for _, _, core, hexa, own in tokens if not hexa for p in own if p in names}
    n = collections.Counter(p for p, _ in {(p, v) for p, _, v in seeds if p in names} | unknown)
    score = {(p, k): x / (n[p] + smooth) for (p, k), x in strong.items()}
    for _ in range(rounds):
        value = collections.defaultdict(lambda: 1.0)
        for p, v in unknown:
            for k in range(len(kinds) + 1):
                if (p, k) in score:
                    value[v, k] *= 1 - score[p, k]
        gained = collections.Counter()
        for p, v in unknown:
            for k in range(len(kinds) + 1):
                if (p, k) in score:
                    gained[p, k] += 1 - value[v, k]
        score = {(p, k): min(1.0, (x + gained[p, k]) / (n[p] + smooth)) for (p, k), x in strong.items()}
    sure = {pk: s for pk, s in score.items() if s >= confident and 2 * strong[pk] >= n[pk[0]]}
    out = collections.defaultdict(set)
    for row, a, core, _, own in tokens:
        if best := max(((s, -k) for (p, k), s in sure.items() if p in own), default=None):
            out[row].add((-best[1], a, a + len(core)))
    return out
