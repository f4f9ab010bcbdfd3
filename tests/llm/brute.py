"""Plain versions of the operators over lists of rows, and small corpora to hold them against."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LAST = (1 << 63) - 1
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def corpus(seed=1, n=60, vocabulary=400):
    """Documents with shared passages, shared lines, copies, odd texts and two sources, one of them hot."""
    rng = random.Random(seed)
    words = [rng.choice("aeiou") + "".join(rng.choice("abcdeénrst") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    passages, lines = [some(30) for _ in range(3)], [" ".join(some(12)) for _ in range(3)]
    out = []
    for i in range(n):
        body = some(rng.randint(5, 120))
        for passage in passages:
            if rng.random() < 0.3:
                at = rng.randrange(len(body))
                body[at:at] = passage[rng.randint(0, 10) : rng.randint(14, 30)]
        parts = [" ".join(body[k : k + 25]) for k in range(0, len(body), 25)]
        parts += [f"  {line.title() if rng.random() < 0.5 else line} \t" for line in lines if rng.random() < 0.3]
        rng.shuffle(parts)
        text = rng.choice(out)[1] if out and rng.random() < 0.15 else "\n".join(parts)
        out.append((i * 3, text, rng.choice(["en", "de", None]), rng.choice(["big", "big", "big", "small", None])))
    out += [(1001, None, "en", "big"), (1002, "", None, "small"), (1003, " \n\t ", "en", None), (1004, "The 1 Ärger", "de", "big")]
    out.append((1005, "the same " * 300, "en", "big"))
    return out


COLUMNS = "doc_id long, text string, lang string, source string"


def words(text):
    return WORD.findall(text or "")


def number(doc_id):
    return LAST if doc_id is None else doc_id


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def removed_passages(rows, width=13):
    least = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            least[key] = min(least.get(key, LAST), number(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        w, gone = words(text), set()
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < number(doc_id):
                gone |= set(range(p, p + width))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def text_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
    covered = {q for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for q in (p, p + 1, p + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Water filling by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, left = {}, set(order)
    budget = share * sum(sizes.values())
    while True:
        rest = budget - sum(capped.values())
        whole = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / whole >= most * sizes[s]]
        if not over:
            return capped | {s: rest * weight[s] / whole for s in left}
        for s in over:
            capped[s] = float(most * sizes[s])
            left.remove(s)
        if not left:
            return capped


def kept_lines(rows, chars=40, docs=5):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    holders = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(number(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(key(x), ())) < docs or max(h) == number(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def benchmark_hits(rows, items, width=10):
    item_words = lambda t: ITEM_WORD.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = item_words(text)
        for p in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[p : p + width]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = item_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if own := windows.get(tuple(w[p : p + size])):
                    hit |= set(range(p, p + size))
                    found |= own
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return out


def simhash(text, shingle=4):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, distance=4):
    """Smallest id that each (id, fingerprint) can reach."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), LAST), doc_id)
    return [least[root(i)] for i in range(len(prints))]


def live_spans(rows):
    """(doc_id, live spans) of each row: values that look random and that one source has."""
    free = re.compile(r"[A-Za-z0-9+/_-]{24,}", re.A)
    random_ = lambda v: len(set(v)) >= 10 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)

    def values(text):
        text = text or ""
        for start, kind, end in base_spans(text):
            value = ASSIGN.fullmatch(text[start:end]).group(2) if kind == 0 else text[start:end]
            yield end - len(value), end, value
        for m in free.finditer(text):
            if all(re.search(c, m.group()) for c in ("[A-Z]", "[a-z]", "[0-9]")):
                yield m.start(), m.end(), m.group()

    owners = {}
    for _, text, _, source in rows:
        for _, _, value in values(text):
            owners.setdefault(value, set()).add(source)
    return [(d, sorted({(a, 3, b) for a, b, v in values(t) if random_(v) and len(owners[v]) == 1})) for d, t, *_ in rows]


def unigram_scores(rows, folds=7, left_out=2):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of each row, and the counts."""
    fold = lambda d: None if d is None else zlib.crc32(str(d).encode()) % folds
    tokens = lambda t: [*(w.translate(LOWER) for w in words(t)), None]
    counts = Counter()
    for doc_id, text, *_ in rows:
        if fold(doc_id) != left_out:
            counts.update(tokens(text))
    n, distinct = sum(counts.values()), len(counts)
    out = []
    for doc_id, text, *_ in rows:
        own = tokens(text)
        base = sum(math.log10((counts[w] + 1) / (n + distinct + 1)) for w in own)
        out.append((doc_id, fold(doc_id) == left_out, len(own), sum(counts[w] > 0 for w in own), n, base))
    return out, counts


def outlier_distances(rows, floors, share, median, inner):
    """Scaled squared distances by minimum covariance determinant, from (lang, source, features) of sound texts in large groups.

    Distances are sorted instead of counted in bins; all else is as the operator says.
    """
    d = len(floors)
    groups = {}
    for lang, source, x in rows:
        groups.setdefault((lang, source), set()).add(tuple(x))

    def shape(x, weights=None):
        w = np.ones(len(x)) if weights is None else weights
        mean = (w[:, None] * x).sum(0) / w.sum()
        return mean, (w[:, None] * x).T @ x / w.sum() - np.outer(mean, mean) + np.diag(np.square(floors))

    def distances(x, mean, cov):
        return ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1)

    def estimate(x):
        q = np.quantile(x, np.arange(21) / 20, axis=0, method="inverted_cdf")
        best = None
        at = np.argmin([q[k + 10] - q[k] for k in range(11)], axis=0)
        halves = [(q[at + 10, range(d)] + q[at, range(d)]) / 2, q[at + 10, range(d)] - q[at, range(d)]]
        for middle, width in ((q[10], q[15] - q[5]), (q[10], 2 * np.minimum(q[15] - q[10], q[10] - q[5])), halves):
            mean, cov, before = middle, np.diag(np.square(width / 1.349) + np.square(floors)), math.inf
            while True:
                order = np.argsort(distances(x, mean, cov), kind="stable")
                left = min(len(x), len(x) * share + (d + 1) / 2)
                weights = np.clip(left - np.arange(len(x)), 0, 1)
                mean, cov = shape(x[order], weights)
                now = np.linalg.slogdet(cov)[1]
                if now > before - 1e-3:
                    break
                before = now
            best = min(best or (math.inf,), (now, mean.tolist(), cov.tolist()))
        mean, cov = np.array(best[1]), np.array(best[2])
        d2 = distances(x, mean, cov)
        mean, cov = shape(x[d2 <= inner * np.median(d2) / median])
        return mean, cov, np.median(distances(x, mean, cov)) / median

    found = {name: estimate(np.array(sorted(x))) for name, x in groups.items()}
    out = []
    for lang, source, x in rows:
        mean, cov, scale = found[lang, source]
        out.append(float(distances(np.array([x]), mean, cov)[0] / max(scale, 1.0)))
    return out
