"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def byte_ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_encoder():
    return tiktoken.Encoding("brute", pat_str=P.PATTERN, mergeable_ranks=byte_ranks(), special_tokens={})


def byte_bpe(docs):
    encoder = byte_encoder()
    out = set()
    for doc_id, text in docs:
        ids = encoder.encode_ordinary(text or "")
        out.add((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(encoder.decode_bytes(ids))))
    return out


def token_files(docs):
    """docs in their order."""
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ASSIGN = re.compile(
    r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)


def secrets(text):
    """(start, kind, end) of the base kinds, in order."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


KINDS = ("assign", "access", "hex", "example", "live")


def span_text(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def chat(rows):
    """rows of (conv_id, turn, role, text), in the order of turns."""
    convs = {}
    for conv_id, _, role, text in rows:
        convs.setdefault(conv_id, []).append((role or "", text or ""))
    out = set()
    for conv_id, turns in convs.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        size = sum(
            len("<s>[]</s>") + sum(len(x) + len(re.findall(r"[\\<\[\]]", x)) for x in turn)
            for turn in turns
        )
        out.add((conv_id, len(turns), sha(whole.encode()), len(learned), sha(learned.encode()), size))
    return out


def shingles(text, n):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) >= n:
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def linked(docs, n, share):
    """(doc_id, n_shingles, component_id), comparing all pairs that share a shingle."""
    sets = [(d, shingles(t, n)) for d, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for i, (_, s) in enumerate(sets):
        for shingle in s:
            holders.setdefault(shingle, []).append(i)
    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :]}
    for a, b in pairs:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= share * (len(sets[a][1]) + len(sets[b][1]) - both):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        root = find(i)
        if d is not None:
            least[root] = min(least.get(root, d), d)
    return [(d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)]


def without_near_copies(docs, n, share):
    """The (doc_id, text) that stay: of each component the first by doc_id (null last) and hash."""
    groups = {}
    for (i, size, group), (d, t) in zip(linked([(i, t) for i, (_, t) in enumerate(docs)], n, share), docs, strict=True):
        key = hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).digest()
        groups.setdefault(group if size else (i,), []).append(((d is None, d or 0, key), d, t))
    return [min(rows, key=lambda row: row[0])[1:] for rows in groups.values()]


def without_copies(docs):
    """The (doc_id, text) that stay of texts equal but for white space."""
    groups = {}
    for d, t in docs:
        key = re.sub("[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(key, []).append(((-len(t or ""), d is None, d or 0, t or ""), d, t))
    return [min(rows, key=lambda row: row[0])[1:] for rows in groups.values()]


def lengths(texts):
    encoder = byte_encoder()
    return [len(encoder.encode_ordinary(t or "")) for t in texts]


BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bench_words(text):
    return re.findall(BENCH_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, items, window=10):
    """(doc_id, n_words, n_hit, items hit) by looking for every window at every word."""
    wanted = {}
    for name, text in items:
        words = bench_words(text)
        size = min(len(words), window)
        for i in range(len(words) - size + 1 if words else 0):
            wanted.setdefault(tuple(words[i : i + size]), set()).add("" if name is None else str(name))
    sizes = {len(w) for w in wanted}
    out = []
    for d, text in docs:
        words, hit, found = bench_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                names = wanted.get(tuple(words[i : i + size]))
                if names:
                    hit.update(range(i, i + size))
                    found |= names
        out.append((d, len(words), hit, found))
    return out


def merkle(rows):
    """rows of (doc_id, source, lang, n_chars, text): (doc_id, leaf, subroot, root, proof, folded, verified)."""

    def h(*parts):
        return sha("".join(parts).encode())

    def leaf(row, text):
        fields = (*row[:4], text)
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])

    def levels(nodes):
        """The siblings (before, after) of each node up to the root, and the root."""
        paths = [[] for _ in nodes]
        below = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            parents, held = [], []
            for start in range(0, len(nodes), 3):
                run = nodes[start : start + 3]
                for k, members in enumerate(below[start : start + 3]):
                    for i in members:
                        paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
                parents.append(h(*run))
                held.append(sum(below[start : start + 3], []))
            nodes, below = parents, held
        return paths, nodes[0]

    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    trees = {}
    for source, members in sources.items():
        keyed = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[4])), r) for r in members)
        trees[source] = [(key[2], r) for key, r in keyed], *levels([key[2] for key, _ in keyed])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top, root = levels([trees[s][2] for s in order])
    out = []
    for source, above in zip(order, top, strict=True):
        leaves, paths, subroot = trees[source]
        for (own, row), path in zip(leaves, paths, strict=True):
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf(row, text)
            for before, after in path + above:
                folded = h(before, folded, after)
            proof = h(*["".join(pair) for pair in path + above])
            out.append((row[0], own, subroot, root, proof, folded, folded == root))
    return out


def spelling(docs, least_length=5, least_count=3):
    """(word, n, n_near, form, form_n, root) by the edits of every word."""
    counts = {}
    for d, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= least_count and len(w) >= least_length}
    letters = sorted({c for w in counts for c in w})
    forms = {}
    for w, n in counts.items():
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near = sorted((-counts[e], e) for e in edits - {w} if e in counts)
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        forms[w] = (n, len(near), form, counts.get(form))
    out = []
    for w, (n, near, form, form_n) in forms.items():
        root = w
        while forms[root][2]:
            root = forms[root][2]
        out.append((w, n, near, form, form_n, root))
    return out


def replicated(rows, total, seed):
    """rows with the source last: (*row, copy, copies, mix_key) of every copy, by the hashes of the rows."""
    sizes = {}
    for row in rows:
        sizes[row[-1]] = sizes.get(row[-1], 0) + 1
    weights = sum(n**0.5 for n in sizes.values())
    seen, out = {}, Counter()
    for row in rows:
        n = sizes[row[-1]]
        rate = float(total) * (n**0.5 / weights) / n
        draws = max(1, math.ceil(rate / 16))
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
        digest = hashlib.md5("".join(parts).encode()).hexdigest()
        seen[row] = number = seen.get(row, 0) + 1
        copies = 0
        for k in range(1, draws + 1):
            u = int(hashlib.md5(f"{seed}:{digest}:{number}:{k}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / draws)
            for j in range(1, 82):
                copies += c <= u
                p *= rate / draws / j
                c += p
        for copy in range(1, copies + 1):
            key = hashlib.md5(f"{seed}:shuffle:{digest}:{number}:{copy}".encode()).hexdigest()
            out[(*row, copy, copies, key)] += 1
    return out


def owned_secrets(rows, owners=2, repositories=8):
    """rows of (doc_id, text, owner): (doc_id, all spans) with the verdict on every value."""
    places, holders = [], {}
    for doc_id, text, owner in rows:
        text = text or ""
        found = []
        for start, kind, end in secrets(text):
            value = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
            found.append((end - len(value), end, value))
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                found.append((m.start(), m.end(), m[0]))
        places.append(found)
        held = (owner or "", "" if doc_id is None else str(doc_id))
        for _, _, value in found:
            texts = holders.setdefault(value, {})
            texts[text] = min(texts.get(text, held), held)
    out = []
    for (doc_id, text, _), found in zip(rows, places, strict=True):
        spans = set(secrets(text))
        for start, end, value in found:
            held = set(holders[value].values())
            lively = len(value) >= 16 and len(set(value)) >= 8 and re.search("[0-9]", value) and re.search("[A-Za-z]", value)
            if len({owner for owner, _ in held}) >= owners or len(held) >= repositories:
                spans.add((start, 3, end))
            elif lively:
                spans.add((start, 4, end))
        out.append((doc_id, sorted(spans)))
    return out


def language(model, text):
    """(language, score) of a text, n-gram by n-gram."""
    text = text or ""
    points = [0, *[ord(low) if len(low := c.lower()) == 1 and c.isalpha() else ord(c) if c.isalpha() else 0 for c in text], 0]
    grams = []
    for n in (1, 2, 3, 4):
        for i in range(len(points) - n + 1):
            gram = points[i : i + n]
            inner = gram if n == 1 else gram[1:-1]
            if not all(inner) or not any(gram):
                continue
            code = n * 0x85EBCA6B % 2**32
            for point in gram:
                code = (code ^ (point * 0x9E3779B1 + 0x7F4A7C15) % 2**32) * 0xC2B2AE35 % 2**32
                code ^= code >> 15
            grams.append(code % 2**15)
    if not grams:
        return "und", 0.0
    size = len(model.languages)
    means, familiar = [0.0] * size, [0.0] * size
    for bucket in grams:
        for k in range(size):
            means[k] += float(model.weights[bucket][k]) / len(grams)
            familiar[k] += float(model.likely[bucket][k]) / len(grams)
    raised = [math.exp((m + float(b)) / model.temperature) for m, b in zip(means, model.bias, strict=True)]
    best = max(range(size), key=raised.__getitem__)
    known = 1 / (1 + math.exp(model.slope * (model.bar - familiar[best])))
    return model.languages[best], raised[best] / sum(raised) * known
