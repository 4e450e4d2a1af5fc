"""Plain Python versions of what the operators' queries return."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def pii(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items, window=10):
    where = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            where.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(k) for k in where}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := where.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        yield doc_id, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)


def frequent_lines(docs, least=10):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x))
    n = {}
    for _, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            n[k] = n.get(k, 0) + 1
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < least]
        yield doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))


def repeated_bytes(docs, n=100):
    """docs in the order of doc_id: what is left of each, by whether a byte is in a string that starts earlier too."""
    seen = set()
    for doc_id, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            if s in seen:
                gone[i : i + n] = True
            seen.add(s)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        yield doc_id, len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))


def gram_buckets(text, buckets=1 << 15):
    """Buckets of the 1-, 2- and 3-grams of a text, one after another."""
    c = [ord(x) for x in f" {text.lower()} "]
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            h = 0
            for x in c[i : i + n]:
                h = (h * 0x9E3779B1 + x) & 0xFFFFFFFF
            yield (((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 17) & (buckets - 1)


def languages(train, texts, smoothing=0.5, buckets=1 << 15):
    """For each text the likeliest label of a multinomial naive Bayes fitted on (text, label), and its score."""
    counts, docs = {}, collections.Counter()
    for text, label in train:
        docs[label] += 1
        counts.setdefault(label, collections.Counter()).update(gram_buckets(text))
    total = {x: math.log(c.total() + smoothing * buckets) for x, c in counts.items()}
    for text in texts:
        if not text or not any(x.isalpha() for x in text):
            yield "und", 0.0
            continue
        grams = list(gram_buckets(text))
        log = {x: math.log(docs[x] / docs.total()) + sum(math.log(c[g] + smoothing) - total[x] for g in grams) for x, c in counts.items()}
        best = min(log, key=lambda x: (-log[x], x))
        yield best, 1 / sum(math.exp((v - log[best]) / math.sqrt(len(grams))) for v in log.values())


def crc(x: bytes) -> int:
    return zlib.crc32(x)
