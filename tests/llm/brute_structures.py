"""Plain versions of the prefix trie, the manifest and the language model."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from brute import WORD, lowered


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(number: int) -> int:
    return zlib.crc32(str(number).encode())


# --- trie -----------------------------------------------------------------------------


def rebuilt(turns: list[tuple], prefix_of_five: bool) -> dict[int, list[tuple[str, str]]]:
    """``turns`` of (conv_id, turn, role, text) as lists of (role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(rows)] for c, rows in own.items()}
    if not prefix_of_five:
        return own
    h = {c: crc(c) % 9 for c in own}
    head = {c: c - int(math.fmod(c, 5)) for c in own}
    return {c: own.get(head[c], [])[: h[c]] + own[c][h[c] :] for c in own}


def trie(turns: list[tuple], prefix_of_five: bool = True) -> set[tuple]:
    members = defaultdict(list)
    convs = rebuilt(turns, prefix_of_five)
    for conv, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(conv)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, convs_of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs_of) - 1) * len(p[-1][1].encode()) if p else 0
    return {
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))),
        )
        for p, m in members.items()
    }


# --- manifest --------------------------------------------------------------------------


def _field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, source, lang, n_chars, text) -> str:
    return sha("".join(map(_field, (doc_id, source, lang, n_chars, text))))


def _way(digests: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for every digest what stands beside its ancestors."""
    sides, at = [[] for _ in digests], list(range(len(digests)))
    level = digests
    while len(level) > 1:
        for i in range(len(digests)):
            a = at[i] - at[i] % arity
            sides[i].append(("".join(level[a : at[i]]), "".join(level[at[i] + 1 : a + arity])))
            at[i] //= arity
        level = [sha("".join(level[a : a + arity])) for a in range(0, len(level), arity)]
    return level[0], sides


def manifest(docs: list[tuple], arity: int) -> list[tuple]:
    """Rows of (doc_id, source, lang, n_chars, text) with leaf, subroot, root, proof, folded root and verdict, sorted."""
    by_source = defaultdict(list)
    for row in docs:
        by_source[row[1]].append(row)
    trees = {}
    for source, rows in by_source.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[source] = (rows, *_way([leaf(*r) for r in rows], arity))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, upper = _way([trees[s][1] for s in order], arity) if order else (None, [])
    out = []
    for source, above in zip(order, upper):
        rows, subroot, sides = trees[source]
        for row, way in zip(rows, sides):
            now = leaf(*row)
            if row[0] is not None and crc(row[0]) % 5 == 0 and row[4] is not None:
                now = leaf(*row[:4], lowered(row[4]))
            for left, right in [*way, *above]:
                now = sha(left + now + right)
            proof = sha("".join(a + b for a, b in [*way, *above]))
            out.append((row[0], leaf(*row), subroot, root, proof, now, now == root))
    return sorted(out, key=repr)


# --- language model ------------------------------------------------------------------------


def _tokens(text: str | None) -> list[str | None]:
    return [*WORD.findall(lowered(text or "")), None]


def _counted(texts: list[list], order: int) -> tuple[list[Counter], list[Counter]]:
    grams, contexts = ([Counter() for _ in range(order + 1)] for _ in range(2))
    for tokens in texts:
        padded = ["<s>"] * (order - 1) + tokens
        for j in range(order - 1, len(padded)):
            for k in range(1, order + 1):
                gram = tuple(padded[j - k + 1 : j + 1])
                grams[k][gram] += 1
                contexts[k][gram[:-1]] += 1
    return grams, contexts


def _cases(tokens: list, grams: list[Counter], contexts: list[Counter], order: int):
    padded = ["<s>"] * (order - 1) + tokens
    for j in range(order - 1, len(padded)):
        all_ = [tuple(padded[j - k + 1 : j + 1]) for k in range(1, order + 1)]
        yield [grams[k][g] for k, g in enumerate(all_, 1)], [contexts[k][g[:-1]] for k, g in enumerate(all_, 1)]


def _bucket(contexts: list[int]) -> int:
    out = 0
    for k, n in enumerate(contexts, 1):
        if n:
            out = 64 if k == 1 else 64 * k + n.bit_length() - 1
    return out


def _weights(known: dict, bucket: int, order: int) -> list[float]:
    same = sorted((abs(b - bucket), b) for b in known if b // 64 == bucket // 64)
    used = bucket // 64 + 1
    return known[same[0][1]] if same else [1 / used] * used + [0.0] * (order + 1 - used)


def _parts(counts, contexts, weights, types) -> list[float]:
    return [weights[0] / (types + 1)] + [w * c / x if x else 0.0 for w, c, x in zip(weights[1:], counts, contexts)]


def language_model(texts: list[str | None], unseen: list[bool], fold: list[bool], order: int, iterations: int, prior: float):
    """``n_tokens, n_known, train_tokens, base_score, score`` of every text."""
    tokens = [_tokens(t) for t in texts]
    grams, contexts = _counted([t for t, u, h in zip(tokens, unseen, fold) if not u and not h], order)
    cases = [c for t, u, h in zip(tokens, unseen, fold) if not u and h for c in _cases(t, grams, contexts, order)]
    types = len(grams[1])
    known = {b: _weights({}, b, order) for b in {_bucket(x) for _, x in cases}}
    for _ in range(iterations):
        sums = {b: [0.0] * (order + 1) for b in known}
        for c, x in cases:
            parts = _parts(c, x, known[_bucket(x)], types)
            for k, p in enumerate(parts):
                sums[_bucket(x)][k] += p / sum(parts)
        for b, found in sums.items():
            used = b // 64 + 1
            known[b] = [(f + prior) / (sum(found) + prior * used) if k < used else 0.0 for k, f in enumerate(found)]
    grams, contexts = _counted([t for t, u in zip(tokens, unseen) if not u], order)
    n, types = sum(grams[1].values()), len(grams[1])
    out = []
    for t in tokens:
        rows = list(_cases(t, grams, contexts, order))
        base = sum(math.log10((c[0] + 1) / (n + types + 1)) for c, _ in rows)
        score = sum(math.log10(sum(_parts(c, x, _weights(known, _bucket(x), order), types))) for c, x in rows)
        out.append((len(t), sum(c[0] > 0 for c, _ in rows), n, base, score))
    return out
