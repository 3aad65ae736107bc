"""Small corpora and brute-force versions that the operators are held against."""

import hashlib
import random
import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def corpus(seed=1, n=60, vocabulary=300, length=80):
    """Texts with exact copies, near copies, shared passages, repeated lines and odd rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
    passage = " ".join(rng.choice(vocab) for _ in range(35))
    line = "A line that many documents hold, word for word."
    texts = []
    for k in range(n):
        kind = k % 6
        body = [rng.choice(vocab) for _ in range(rng.randint(5, length))]
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
        elif kind == 2 and texts:
            old = words(rng.choice(texts)) or body
            for _ in range(max(1, len(old) // 40)):
                old[rng.randrange(len(old))] = rng.choice(vocab)
            texts.append(" ".join(old))
        elif kind == 3:
            cut = rng.randrange(len(body))
            texts.append(" ".join(body[:cut]) + "\n" + passage + "\t" + " ".join(body[cut:]))
        elif kind == 4:
            texts.append(" ".join(body) + "\n  " + (line.upper() if k % 4 else line) + " \n" + " ".join(body[:6]) + "\n" + line)
        else:
            texts.append(" ".join(body))
    texts += [None, "", "   \n\t ", "one", "one two", "x " * 200, " ".join(rng.choice(vocab) for _ in range(5000)), "é ü — 漢字 " * 30, passage]
    return [(i * 3 + 1, t, "en", rng.choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_substrings(rows, n=20):
    first, out = {}, {}
    texts = {d: words(t) for d, t, *_ in rows}
    for d in sorted(texts):
        for i in range(len(texts[d]) - n + 1):
            first.setdefault(tuple(texts[d][i : i + n]), (d, i))
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] != (d, i):
                gone.update(range(i, i + n))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def brute_lines(rows, chars=20, least=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    lines = {d: (t or "").split("\n") for d, t, *_ in rows}
    held = {}
    for d, ls in lines.items():
        for k in {key(x) for x in ls}:
            held.setdefault(k, set()).add(d)
    out = {}
    for d, ls in lines.items():
        kept = [x for x in ls if not (len(key(x)) >= chars and len(held[key(x)]) >= least and d != max(held[key(x)]))]
        out[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def shingles(text, n):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent=80):
    sets = {d: shingles(t, n) for d, t, *_ in rows}
    label = {d: d for d in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def brute_statistics(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered, seen, twice = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if words(line):
            twice += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered))
