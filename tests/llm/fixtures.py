"""A small corpus with every awkward case, and brute-force versions of the operators."""

import random
import re
from collections import Counter

SPACE = "[^\x20\x09-\x0d]+"
ALNUM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) rows."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(600)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, base = text(60), [r.choice(vocab) for _ in range(120)]
    rows = [text(r.randint(15, 200)) for _ in range(30)]
    rows += [" ".join(base)] * 4  # exact copies
    for _ in range(6):  # near copies
        near = list(base)
        for i in r.sample(range(120), 2):
            near[i] = r.choice(vocab)
        rows.append(" ".join(near))
    rows += [f"{text(30)} {shared} {text(20)}" for _ in range(3)]
    rows += [text(40) + "\n" + "same line again and again here now\n" * 20]
    rows += ["", "   \n\t ", None, "one", "Two words", "ÀÉ Üx ÀÉ", text(5000), "a " * 300, "<|endoftext|> x <|endoftext|>", "don't we'll\u2028x\x00y  \n"]
    rows += [f"{benchmark()[0][1]} {text(50)}", f"{text(400)} {benchmark()[1][1]}"]
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    return out + [out[3], out[3], (None, rows[0], None, None, None), (None, None, None, None, None)]


def benchmark() -> list[tuple]:
    r = random.Random(99)
    word = lambda: "".join(r.choice("klmnopqrst") for _ in range(r.randint(3, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 13, 20, 4))]
    return [*items, (7, None), (8, "!!"), items[0], (9, "Two, words")]


def words(text, pattern=SPACE, lower=False):
    return re.findall(pattern, (text or "").translate(LOWER) if lower else text or "")


def repeat_words(ws, n=8):
    grams = Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    hit = set()
    for i in range(len(ws) - n + 1):
        if grams[tuple(ws[i : i + n])] > 1:
            hit.update(range(i, i + n))
    return len(hit)


def kept_words(texts, n=35):
    lists = [words(t) for t in texts]
    grams = Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - n + 1):
            if grams[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def shingles(text, k):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(rows, k, percent=80):
    """doc_id -> least reachable doc_id; rows without id are left out."""
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, set()).add(shingles(t, k))
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    common = len(x & y)
                    if common and 100 * common >= percent * (len(x) + len(y) - common):
                        p, q = find(a), find(b)
                        up[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def contamination(text, items, n=13):
    w = words(text, ALNUM, True)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t, ALNUM, True)
        size = min(n, len(iw))
        for i in range(len(iw) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == iw[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)
