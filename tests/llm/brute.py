"""Plain answers of the ten operators for small tables."""

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def token_rows(docs, tokenizer, end=2):
    out, start = [], 0
    for doc_id, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def repeats(docs, window=20):
    seen, out = set(), []
    for doc_id, text in sorted(docs):
        words = WORD.findall(text or "")
        gone = set()
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if key in seen:
                gone.update(range(a, a + window))
            seen.add(key)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((doc_id, len(words), len(gone), sha(" ".join(kept))))
    return out


def leaks(docs, items, window=10):
    tests = []
    for item, text in items:
        words = ALNUM.findall(lower(text or ""))
        for a in range(max(1, len(words) - window + 1) if words else 0):
            tests.append((str(item), tuple(words[a : a + window])))
    by_window = {}
    for item, key in tests:
        by_window.setdefault(key, set()).add(item)
    sizes = {len(k) for k in by_window}
    out = []
    for doc_id, text in sorted(docs):
        words = ALNUM.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(words) - n + 1):
                key = tuple(words[a : a + n])
                if key in by_window:
                    hit.update(range(a, a + n))
                    found |= by_window[key]
        out.append((doc_id, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def base_rules(docs):
    out = []
    for doc_id, text in sorted(docs):
        text = text or ""
        words = WORD.findall(text)
        places = {}
        for a in range(len(words) - 7):
            places.setdefault(tuple(words[a : a + 8]), []).append(a)
        again = set()
        for at in places.values():
            if len(at) > 1:
                for a in at:
                    again.update(range(a, a + 8))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        out.append(
            (doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed)
        )
    return out


def shingle_sets(docs, n=5):
    out = {}
    for doc_id, text in docs:
        words = WORD.findall(lower(text or ""))
        out[doc_id] = {tuple(words[a : a + n]) for a in range(max(1, len(words) - n + 1))} if words else set()
    return out


def components(docs, percent=75):
    sets = shingle_sets(docs)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(sets[i]), find(i)) for i in ids]


def bpe_rows(docs, encoding):
    out = []
    for doc_id, text in sorted(docs):
        ids = encoding.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha((text or "").encode())))
    return out
