"""The slow, obvious way to compute what the engine computes, in plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from hashlib import md5

TOKEN_BREAK = re.compile("[ \t\n\x0b\f\r]+")


def tokens(text):
    return [t for t in TOKEN_BREAK.split(text) if t]


def sentences(text):
    return [s for s in re.split("(?:\n|\r)+", text) if s]


def index_vector(word, size, k):
    cells = {}
    for i in range(k):
        start, end = i * size // k, (i + 1) * size // k
        offset = int(md5(f"{word}#{i}".encode()).hexdigest()[:8], 16)
        bit = int(md5(f"{word}#{i // 2}".encode()).hexdigest()[15], 16) % 2
        cells[start + offset % (end - start)] = 1 if (bit + i) % 2 == 0 else -1
    return cells


def _clean(lexicon):
    return {w: {d: v for d, v in cells.items() if v} for w, cells in lexicon.items()}


def ordered(lines, space):
    """Every token gets the index vectors of all others of its line, turned by their distance."""
    lexicon = defaultdict(Counter)
    for line in lines:
        words = tokens(line)
        for i, word in enumerate(words):
            lexicon[word].update({})
            for j, seen in enumerate(words):
                if i != j:
                    for dim, val in index_vector(seen, space.size, space.k).items():
                        lexicon[word][(dim + j - i) % space.size] += val
    return _clean(lexicon)


def windowed(texts, space):
    lexicon = defaultdict(Counter)
    for text in texts:
        words = tokens(text)
        for i, word in enumerate(words):
            lexicon[word].update({})
            for j in range(max(0, i - space.radius), min(len(words), i + space.radius + 1)):
                if i != j:
                    for dim, val in index_vector(words[j], space.size, space.k).items():
                        lexicon[word][dim] += val
    return _clean(lexicon)


def unit(cells):
    length = math.sqrt(sum(v * v for v in cells.values()))
    return {d: v / length for d, v in cells.items()} if length else {}


def mean(lexicon):
    total = Counter()
    for cells in lexicon.values():
        for d, v in unit(cells).items():
            total[d] += v
    return {d: v / len(lexicon) for d, v in total.items()}


def text_vector(words, lexicon, size):
    """Dense sum of unit word vectors less the mean, and the number of known words."""
    centre, vec, n = mean(lexicon), [0.0] * size, 0
    for word in words:
        if word in lexicon:
            n += 1
            for d, v in unit(lexicon[word]).items():
                vec[d] += v
            for d, v in centre.items():
                vec[d] -= v
    return (n, vec) if n else None


def cosine(a, b):
    la, lb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
    return sum(x * y for x, y in zip(a, b)) / (la * lb) if la and lb else None


def as_dict(lexicon_df):
    return {r.key: dict(zip(r.vec.dims, r.vec.vals)) for r in lexicon_df.collect()}
