"""Plain, slow versions of the corpus operators."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = r"[\x20\x09-\x0D]"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, width=4):
    ws = words(lower_ascii(text))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints, bits=4):
    """Least index reachable of each fingerprint."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def similar_groups(texts, width=5, threshold=0.8):
    """Least index reachable of each text by chains of Jaccard likeness of its word shingles."""
    sets, root = [], list(range(len(texts)))
    for t in texts:
        ws = words(lower_ascii(t))
        sets.append(frozenset(" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))) if ws else frozenset())
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= threshold * len(a | b):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def dedup_lines(docs):
    """[(id, text)] in order of id -> {id: (text, n_lines, n_removed)}."""
    seen, gone = {}, defaultdict(set)
    for doc_id, text in docs:
        if text is None:
            continue
        lines = [(i, x) for i, x in enumerate(s.strip(" \t\n\v\f\r") for s in text.split("\n")) if x]
        for k in range(len(lines) - 2):
            passage = tuple(x for _, x in lines[k : k + 3])
            if seen.setdefault(passage, (doc_id, k)) != (doc_id, k):
                gone[doc_id].update(i for i, _ in lines[k : k + 3])
    out = {}
    for doc_id, text in docs:
        if text is None:
            out[doc_id] = (None, 0, 0)
        else:
            ls = text.split("\n")
            out[doc_id] = ("\n".join(x for i, x in enumerate(ls) if i not in gone[doc_id]), len(ls), len(gone[doc_id]))
    return out


def uniform(seed, *parts):
    named = "/".join([str(seed), *("" if p is None else str(p) for p in parts)])
    return int(hashlib.md5(named.encode()).hexdigest()[:13], 16) / 2**52


def poisson(mean, u):
    k, chance = 0, math.exp(-mean)
    upto = chance
    while u >= upto and k < mean + 12 * math.sqrt(mean) + 40:
        k += 1
        chance *= mean / k
        upto += chance
    return k


def mixture(docs, seed=17):
    """[(id, text, source)] -> Counter of (id, copies)."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(text or "")
    raw = {s: math.sqrt(n) for s, n in sizes.items()}
    rate = {s: round(raw[s] / sum(raw.values()) * sum(sizes.values()) / n, 12) if n else 1.0 for s, n in sizes.items()}
    out = []
    for i, text, source in docs:
        u = uniform(seed, i, hashlib.md5((text or "").encode()).hexdigest())
        out += [(i, r) for r in range(poisson(rate[source], u))]
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(ws) - 2):
        at[tuple(ws[i : i + 3])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def signatures(text, anchors, chain=2):
    ws = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    content = [(i, w) for i, w in enumerate(ws) if w not in anchors]
    out = set()
    for i, w in enumerate(ws):
        if w in anchors:
            nxt = [c for j, c in content if j > i][:chain]
            if len(nxt) == chain:
                out.add((w, *nxt))
    return out or {tuple(ws)}


def toxicity(text, weights, bias, span=16, sizes=(3, 4, 5)):
    """The chance of label 1: of the span of words with the greatest mean, a word being the mean of its subwords' weights."""
    mask, mult = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def of_word(word):
        core = word.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—\n")
        rows = [zlib.crc32(core.encode()) * mult & mask]
        marked = f"<{core}>"
        for n in sizes:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = (h ^ ord(c)) * mult & mask
                    h ^= h >> 29
                rows.append(h * mult & mask)
        values = [weights[(h >> 40) % len(weights)] for h in rows]
        return sum(values) / len(values)

    found = [of_word(w) for w in words(text)]
    cuts = list(range(0, len(found), span))
    if len(cuts) > 1 and len(found) - cuts[-1] < span // 2:
        cuts.pop()
    means = [sum(s) / len(s) for s in (found[a:b] for a, b in zip(cuts, [*cuts[1:], len(found)]))]
    return 1 / (1 + math.exp(-(bias + max(means, default=0))))


def letters(text):
    """Lower-cased, with a blank for each run of other characters, and one in front."""
    return re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()))


def substrings(text, longest):
    text = letters(text)
    return {text[i : i + k] for k in range(1, longest + 1) for i in range(len(text) - k + 1)}


def cross_parse(text, samples, sets=None):
    """({language: phrases}, {language: bits of a phrase}) of a text.

    sets: the samples' substrings up to some length; longer ones are looked up in the sample.
    """
    text, counts, bits = letters(text), {}, {}
    for lang, sample in samples.items():
        plain = letters(sample)
        inside = (sets or {}).get(lang) or ()
        longest = max(map(len, inside), default=0)
        at = phrases = 0
        while at < len(text):
            end = at + 1
            while end < len(text) and (text[at : end + 1] in inside or (end + 1 - at > longest and text[at : end + 1] in plain)):
                end += 1
            at, phrases = end, phrases + 1
        counts[lang], bits[lang] = phrases, math.log2(max(2, len(plain)))
    return counts, bits


class ContextTree:
    """Context-tree weighting with plain dictionaries: a decision is (context bytes, bits decided, with a 1 in front)."""

    def __init__(self, texts, depth):
        self.depth, self.nodes, self.weights = depth, {}, {}
        for text in texts:
            for context, byte in self.coded(text):
                for bits in range(8):
                    prefix, bit = 1 << bits | byte >> (8 - bits), byte >> (7 - bits) & 1
                    for d in range(depth + 1):
                        self.nodes.setdefault((context[depth - d :], prefix), [0, 0])[bit] += 1
        self.below = defaultdict(float)
        for context, prefix in sorted(self.nodes, key=lambda x: -len(x[0])):
            zeros, ones = self.nodes[context, prefix]
            own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
            if len(context) == depth:
                weighted, stay = own, 1.0
            else:
                below = self.below[context, prefix]
                top = max(own, below)
                weighted = top + math.log((math.exp(own - top) + math.exp(below - top)) / 2)
                stay = 1 / (1 + math.exp(max(-700, min(700, below - own))))
            self.weights[context, prefix] = stay
            if context:
                self.below[context[1:], prefix] += weighted

    def coded(self, text):
        raw = b"\n" * self.depth + " ".join(words(lower_ascii(text))).encode("utf-8", "surrogatepass") + b"\n"
        for i in range(self.depth, len(raw)):
            yield raw[i - self.depth : i], raw[i]

    def one(self, context, prefix, depth=0):
        """Chance of a one, mixed over the depths from that on."""
        node = context[self.depth - depth :]
        if (node, prefix) not in self.nodes:
            return 0.5
        zeros, ones = self.nodes[node, prefix]
        stay, own = self.weights[node, prefix], (ones + 0.5) / (zeros + ones + 1)
        return own if depth == self.depth else stay * own + (1 - stay) * self.one(context, prefix, depth + 1)

    def score(self, text):
        total = 0.0
        for context, byte in self.coded(text):
            for bits in range(8):
                chance = self.one(context, 1 << bits | byte >> (8 - bits))
                total += math.log10(chance if byte >> (7 - bits) & 1 else 1 - chance)
        return total
