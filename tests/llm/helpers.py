"""Small corpora with the awkward cases, and brute-force versions of what the operators compute."""

import random
import re
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED, lower=True):
    return pattern.findall((text or "").translate(LOWER) if lower else text or "")


def corpus(seed=3, n=120):
    """Texts with copies, near copies, shared passages, empty, blank, null and long ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(400)]

    def prose(k):
        return " ".join(r.choice(vocabulary) for _ in range(k))

    passage = prose(60)
    texts = [prose(r.randint(1, 120)) for _ in range(n)]
    for k in range(0, n, 6):
        w = texts[k].split()
        w[r.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [t for t in texts[:15]] + [prose(20) + " " + passage + " " + prose(k) for k in range(8)]
    texts += ["", "   \n\t", None, None, "a", "A", "x" * 3000, ("To " * 400).strip(), "line one\nline one\nline one\n" * 30, prose(9000)]
    r.shuffle(texts)
    return texts


COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, sid string, n string, key string, tid string, "
           "score string, lang_pred string, label string, item_id string")


def frame(spark, texts, langs=None):
    """A documents table with extra columns whose names clash with inner ones, over several partitions."""
    rows = [(i, t, langs[i] if langs else "en", None if i % 7 == 0 else "s", None if t is None else len(t),
             "x", "y", "z", "t", "s", "p", "l", "q") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def jaccard_components(texts, size=4, link=(85, 100)):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size
                    else frozenset([tuple(w)]) if w else frozenset())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in where[x] if j > i).items():
            if link[1] * both >= link[0] * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


def repeated_spans(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        spans = []
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        out.append([tuple(s) for s in spans])
    return out


def without(raw, spans):
    out, at = b"", 0
    for a, z in spans:
        out, at = out + raw[at:a], z
    return out + raw[at:]
