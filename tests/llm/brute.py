"""Plain versions of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

SPACED = re.compile("[^\\x20\\x09-\\x0D]+")
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_duplicates(docs):
    """doc_id -> (shingles, smallest reachable id), from all pairs that share a shingle."""
    sets = {}
    for i, text in docs:
        w = SPACED.findall(lower(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders = defaultdict(list)
    for i, grams in sets.items():
        for g in grams:
            holders[g].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, grams in sets.items():
        for j, common in Counter(j for g in grams for j in holders[g] if j > i).items():
            if 100 * common >= 75 * (len(grams) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(texts, length=400):
    """For each text its bytes, and for each byte whether a repeated string covers it."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((d, gone))
    return out


def left_of(data, gone):
    return np.frombuffer(data, np.uint8)[~gone].tobytes()


def repeat_row(data, gone):
    kept = left_of(data, gone)
    spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
    return len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def contamination(docs, items, window=10):
    """doc_id -> (words, hit words, items found as sorted strings)."""
    found = {}
    listed = [(i, WORD.findall(lower(t))) for i, t in items]
    for d, text in docs:
        words = WORD.findall(lower(text))
        hit, ids = set(), set()
        for i, item in listed:
            for k in range(max(1, len(item) - window + 1)) if item else ():
                part = item[k : k + window]
                for at in range(len(words) - len(part) + 1):
                    if words[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        ids.add(str(i))
        found[d] = (len(words), len(hit), sorted(ids))
    return found


def base_quality(text):
    text = text or ""
    words = SPACED.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {p for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for p in range(k, k + 3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def base_licenses(text):
    words = WORD.findall(lower(text))
    places = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))
