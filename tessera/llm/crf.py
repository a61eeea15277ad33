"""A linear-chain conditional random field that tags tokens as begin, inside or outside of a secret."""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

OUT, BEGIN, INSIDE = range(3)
NEVER = -1e6
TOKEN = re.compile(r"\w[\w+/-]*|[^\w\s]")
PLAIN_END = frozenset(".,;:!?")
# Words that announce a secret, and words between these and the secret (fixed values)
CUES = re.compile(
    r"(?ai)pass(?:words?|wd|phrase|code|wort)?|pwd|secrets?|tokens?|api_?-?keys?|x-api-key|keys?|bearer|basic|auth\w*|credentials?|creds?|private|login|pin|passwort|kennwort|clave|contrase(?:ñ|n)a|mdp|motdepasse|[a-z_-]*_(?:key|token|secret|password|pass|pwd)"
)
LINKS = frozenset("is was are be to with the = : ist es son est le la der das die lautet".split())
LENGTHS = (1, 2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64)
HEX = re.compile(r"[0-9a-f]{8,}")
NO_VOWELS = dict.fromkeys(map(ord, "aeiouyäöüàâéèêëíîïóôúûá"))


def _bucket(n: int, steps: tuple[int, ...] = LENGTHS) -> int:
    return bisect_right(steps, n)


def shape(token: str) -> tuple[str, int]:
    """What kinds of characters a token has, how they mix and its length; and a coarse class from 0 to 9."""
    if len(token) == 1 and not token.isalnum():
        return (token if token.isascii() else "?"), 0
    low = token.lower()
    if CUES.fullmatch(token):
        return "cue", 1
    if low in LINKS:
        return f"link:{low}", 2
    n = len(token)
    if token.isalpha():
        if token.islower():
            return f"lower{_bucket(n)}", 3
        if token[1:].islower() or n == 1:
            return f"Cap{_bucket(n)}", 3
        if token.isupper():
            return f"UPPER{_bucket(n)}", 4
        turns = sum(a.isupper() != b.isupper() for a, b in zip(token, token[1:], strict=False))
        return f"mixed{_bucket(n)}/{min(turns, 6) // 2}", 5
    if token.isdigit():
        return f"digits{_bucket(n)}", 6
    kinds = [("d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c if c in "_-+/" else "?") for c in token]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    letters = "".join(sorted(set(kinds)))
    return f"{letters}{_bucket(n)}/{_bucket(turns, (2, 4, 8, 16))}{'h' if HEX.fullmatch(token) else ''}", 7 if "d" in letters and n >= 8 else 8 if "d" in letters else 9


def detail(token: str, coarse: int) -> str:
    """How a word is spelled: the share of vowels, and of what is no plain word the bits of entropy too."""
    n = len(token)
    if n < 4:
        return "-"
    vowels = 1 - len(token.lower().translate(NO_VOWELS)) / n
    share = int(vowels > 0.2) + int(vowels > 0.65)
    if coarse in (3, 4):
        return f"word{share}{'+' * (n > 15)}"
    bits = -sum(c / n * math.log2(c / n) for c in map(token.count, set(token)))
    return f"{round(2 * bits)}/{share}/{n > 15}"


class Lexicon:
    """Numbers of the shapes, details and beginnings that were seen in training; 0 is for all others, 1 for the bounds of texts."""

    def __init__(self, growing: bool = True):
        self.growing = growing
        self.shapes, self.details, self.heads = {"?": 0, "<text>": 1}, {"?": 0}, {"?": 0}

    def number(self, table: dict[str, int], name: str) -> int:
        if self.growing:
            return table.setdefault(name, len(table))
        return table.get(name, 0)


COARSE, FILES, DISTANCES = 10, 64, 8
GLUED = 1 << 52


class Words(dict):
    """Of each word between white space the place of its first token in columns that grow; a bounded cache."""

    def __init__(self, lexicon: Lexicon, most: int = 500_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.tokens: dict[str, int] = {}
        # the bound of a text is word 0; of each word where its tokens start, and the end of all
        self.first = array("i", [0, 1])
        #: Of each token its features' numbers in one, and where it lies in its word.
        self.codes, self.places = array("q", [1]), array("q", [0])

    def __missing__(self, word: str) -> int:
        codes, places, known = self.codes, self.places, self.tokens
        if word.isalpha():
            codes.append(known.get(word) or self.look_up(word))
            places.append(len(word))
        else:
            last = 0
            for m in TOKEN.finditer(word):
                start, end = m.span()
                code = known.get(m[0]) or self.look_up(m[0])
                codes.append(code | GLUED if start == last and start else code)
                places.append(start << 32 | end)
                last = end
        self[word] = len(self.first) - 1
        self.first.append(len(codes))
        return len(self.first) - 2

    def look_up(self, token: str) -> int:
        lex = self.lexicon
        name, coarse = shape(token)
        head = lex.number(lex.heads, token[:4]) if coarse in (5, 7, 8, 9) else 0
        code = self.tokens[token] = lex.number(lex.shapes, name) | lex.number(lex.details, detail(token, coarse)) << 16 | head << 28 | coarse << 48
        return code

    def columns(self, ids: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """How many tokens each word has, and all their columns."""
        numbers = lambda x, kind: np.frombuffer(x, kind).copy()
        first = numbers(self.first, np.int32)
        start, count = first[ids], (first[1:] - first[:-1])[ids]
        at = np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)
        code, place = numbers(self.codes, np.int64)[at], numbers(self.places, np.int64)[at]
        part = lambda shift, bits: ((code >> shift) & ((1 << bits) - 1)).astype(np.int32)
        return count, {"shape": part(0, 16), "detail": part(16, 12), "head": part(28, 20), "coarse": part(48, 4), "glued": part(52, 1), "start": (place >> 32).astype(np.int64), "end": place & 0xFFFFFFFF}


def file_number(text: str) -> int:
    """How a whole text is written: signs of code and its length."""
    return ("=" in text) + 2 * ("{" in text) + 4 * (";" in text) + 8 * min(len(text).bit_length() // 3, 7)


@dataclass
class Tokens:
    """All tokens of some texts with a bound before and after each text, and their features' numbers."""

    features: list[np.ndarray]
    shape: np.ndarray
    #: The word of each token, counted over all texts with their bounds, and the token's place in it.
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: The first word of each text.
    firsts: np.ndarray

    def bound(self) -> np.ndarray:
        return self.shape == 1


def tokens_of(texts: list[str], words: Words) -> Tokens:
    """Every token of the whole texts with its features: shape, spelling, neighbours' shapes, distance from a cue, the file."""
    if len(words) > words.most:
        words.restart()
    ids, firsts, files, sizes = [0], [], [], [1]
    look_up = words.__getitem__
    for text in texts:
        firsts.append(len(ids))
        found = text.split()
        ids.extend(map(look_up, found))
        ids.append(0)
        files.append(file_number(text))
        sizes.append(len(found) + 1)
    ids = np.array(ids)
    count, c = words.columns(ids)
    word = np.repeat(np.arange(len(ids)), count)
    file = np.repeat(np.array([0, *files]), sizes)[word]
    s, coarse, n = c["shape"], c["coarse"], len(word)
    pad = lambda x, by: np.concatenate([np.ones(by, x.dtype), x[:-by]]) if by > 0 else np.concatenate([x[-by:], np.ones(-by, x.dtype)])
    before, before2, after = pad(s, 1), pad(s, 2), pad(s, -1)
    # nothing is seen beyond the bound of a text
    before2 = np.where(before == 1, 1, before2)
    place = np.arange(n)
    # the last cue or bound before a token; a bound is as far as can be
    mark = np.where((coarse == 1) | (s == 1), place, 0)
    last = pad(np.maximum.accumulate(mark), 1).astype(np.int64)
    last[0] = 0
    distance = np.where(s[last] == 1, DISTANCES - 1, np.minimum(place - last, DISTANCES - 1))
    total = 1 + max(words.lexicon.shapes.values())
    features = [
        s, c["detail"], c["head"], before, before2, after, before * total + s, s * total + after,
        distance * COARSE + coarse, (c["glued"] * COARSE + coarse) * COARSE + pad(coarse, 1), file * COARSE + coarse,
    ]
    return Tokens(features, s, word, c["start"], c["end"], np.array(firsts))


def spans_of(tags: np.ndarray, tokens: Tokens, texts: list[str]) -> list[list[tuple[int, int]]]:
    """The tagged spans of each text, in its characters."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    hits = np.flatnonzero(tags != OUT)
    of = np.searchsorted(tokens.firsts, tokens.word[hits], side="right") - 1
    for k in np.unique(of):
        starts = [m.start() for m in re.finditer(r"\S+", texts[k])]
        last = -2
        for t in hits[of == k]:
            base = starts[tokens.word[t] - tokens.firsts[k]]
            start, end = base + int(tokens.start[t]), base + int(tokens.end[t])
            if tags[t] == INSIDE and t == last + 1 and out[k]:
                out[k][-1] = (out[k][-1][0], end)
            else:
                out[k].append((start, end))
            last = t
    return out


@dataclass
class Model:
    """Weights of each feature's numbers and of the transitions, in log space."""

    lexicon: Lexicon
    emit: list[np.ndarray] = field(default_factory=list)
    move: np.ndarray = field(default_factory=lambda: blocked() + 0.0)
    #: What is taken off the score of being outside: recall against false alarms.
    leaning: float = 0.0

    def scores(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros((len(tokens.shape), 3), np.float32)
        for weights, ids in zip(self.emit, tokens.features, strict=True):
            out += weights[ids]
        out[tokens.bound(), 1:] = NEVER
        return out

    def tags(self, tokens: Tokens) -> np.ndarray:
        if not self.emit:
            return np.zeros(len(tokens.shape), np.int8)
        scores = self.scores(tokens).astype(np.float64)
        scores[:, OUT] -= self.leaning
        return best_tags(scores, self.move, tokens.bound())


def blocked() -> np.ndarray:
    out = np.zeros((3, 3))
    out[OUT, INSIDE] = NEVER
    return out


def surely_outside(scores: np.ndarray, move: np.ndarray, bounds: np.ndarray, passes: int = 6) -> np.ndarray:
    """Tokens that are outside on each best path, the bounds being so.

    Let a best path tag token t as x, not outside. With t made outside, and an
    inside tag of the next token made a begin, the path stays allowed. Its score
    changes by the difference of t's scores, by that of the transition into t
    and that out of t, and, if the next token was inside, by the next token's
    scores and the transition after it. If that is above zero for all tags that
    the neighbours may have, the path was not the best. What is known of the
    neighbours from one pass leaves fewer tags for the next.
    """
    m = move
    allowed = move > NEVER / 2
    sure = bounds.copy()
    nothing = np.full(len(scores), np.inf)
    for _ in range(passes):
        before, after = np.append(True, sure[:-1]), np.append(sure[1:], True)
        ok = np.ones(len(scores), bool)
        for x in (BEGIN, INSIDE):
            into_any = min(m[a, OUT] - m[a, x] for a in range(3) if allowed[a, x])
            into = np.where(before, m[OUT, OUT] - m[OUT, x] if allowed[OUT, x] else np.inf, into_any)
            follow = min(m[OUT, c] - m[x, c] for c in (OUT, BEGIN))
            inside = m[OUT, BEGIN] - m[x, INSIDE] + min(m[BEGIN, d] - m[INSIDE, d] for d in range(3))
            next_ = np.append(scores[1:, BEGIN] - scores[1:, INSIDE], 0) + inside if allowed[x, INSIDE] else nothing
            out_of = np.where(after, m[OUT, OUT] - m[x, OUT], np.minimum(follow, next_))
            ok &= scores[:, OUT] - scores[:, x] + into + out_of > 1e-9
        ok |= bounds
        if (ok == sure).all():
            break
        sure = ok | sure
    return sure


def best_tags(scores: np.ndarray, move: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best path over all tokens, the first and last of which are bounds: Viterbi on each stretch between tokens that are surely outside."""
    tags = np.zeros(len(scores), np.int8)
    open_ = ~surely_outside(scores, move, bounds)
    edges = np.flatnonzero(np.diff(open_.astype(np.int8)))
    starts, sizes = edges[::2] + 1, edges[1::2] - edges[::2]
    # stretches of one length are decoded together
    for size in np.unique(sizes):
        at = starts[sizes == size][:, None] + np.arange(size)
        tags[at] = viterbi(scores[at], move)
    return tags


def viterbi(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags of sequences (n, length, 3) that stand between tokens that are outside."""
    if len(scores) < 8:
        return np.array([_viterbi(one.tolist(), move.tolist()) for one in scores], np.int8).reshape(scores.shape[:2])
    best, back = scores[:, 0] + move[OUT], []
    for i in range(1, scores.shape[1]):
        paths = best[:, :, None] + move
        back.append(paths.argmax(axis=1))
        best = paths.max(axis=1) + scores[:, i]
    out = np.empty(scores.shape[:2], np.int8)
    out[:, -1] = (best + move[:, OUT]).argmax(axis=1)
    for i in range(len(back) - 1, -1, -1):
        out[:, i] = np.take_along_axis(back[i], out[:, i + 1, None].astype(np.intp), axis=1)[:, 0]
    return out


def _viterbi(rows: list[list[float]], m: list[list[float]]) -> list[int]:
    x, y, z = (rows[0][k] + m[OUT][k] for k in range(3))
    back = []
    for row in rows[1:]:
        step, best = [], []
        for k in range(3):
            a, b, c = x + m[0][k], y + m[1][k], z + m[2][k]
            at, top = (0, a) if a >= b and a >= c else (1, b) if b >= c else (2, c)
            step.append(at)
            best.append(top + row[k])
        back.append(step)
        x, y, z = best
    ends = [x + m[0][OUT], y + m[1][OUT], z + m[2][OUT]]
    out = [ends.index(max(ends))]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


def marginals(score: np.ndarray, move: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities of each token of sequences that stand between outside tokens, and expected transitions, all in all."""
    steps, go = score.shape[1], np.exp(move)
    shown = np.exp(score - score.max(axis=2, keepdims=True))
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    # what is left of a sum after each step is scaled to one
    now = shown[:, 0] * go[OUT]
    forward[:, 0] = now / now.sum(axis=1, keepdims=True)
    for i in range(1, steps):
        now = (forward[:, i - 1] @ go) * shown[:, i]
        forward[:, i] = np.where(there[:, i, None], now / now.sum(axis=1, keepdims=True), forward[:, i - 1])
    end = go[:, OUT] / go[:, OUT].sum()
    backward[:, -1] = end
    for i in range(steps - 2, -1, -1):
        now = (shown[:, i + 1] * backward[:, i + 1]) @ go.T
        backward[:, i] = np.where(there[:, i + 1, None], now / now.sum(axis=1, keepdims=True), end)
    node = forward * backward
    node = node / node.sum(axis=2, keepdims=True) * there[..., None]
    pairs = forward[:, :-1, :, None] * go * (shown * backward)[:, 1:, None, :]
    expected = (pairs / pairs.sum(axis=(2, 3), keepdims=True) * there[:, 1:, None, None]).sum(axis=(0, 1))
    expected[OUT] += node[:, 0].sum(axis=0)
    last = there.sum(axis=1) - 1
    expected[:, OUT] += node[np.arange(len(node)), last].sum(axis=0)
    return node, expected


def gold_tags(tokens: Tokens, texts: list[str], spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """The tags that spans of secrets give to the tokens that lie within them."""
    tags = np.zeros(len(tokens.shape), np.int8)
    bounds = [*np.searchsorted(tokens.word, tokens.firsts).tolist(), len(tags)]
    for k, wanted in enumerate(spans):
        if not wanted:
            continue
        starts = [m.start() for m in re.finditer(r"\S+", texts[k])]
        now = None
        for t in range(bounds[k], bounds[k + 1] - 1):
            if tokens.shape[t] == 1:
                continue
            base = starts[tokens.word[t] - tokens.firsts[k]]
            inside = next((s for s in wanted if s[0] <= base + tokens.start[t] and base + tokens.end[t] <= s[1]), None)
            if inside is not None:
                tags[t] = INSIDE if inside is now else BEGIN
            now = inside
    return tags


#: Chosen on held-out passages: more recall, and still few false alarms.
LEANING = 1.5


def fit(texts: list[str], spans: list[list[tuple[int, int]]], epochs: int = 40, penalty: float = 1e-3, step: float = 0.3) -> Model:
    """Maximise the penalised conditional likelihood by adaptive gradient steps, batch by batch; nothing in it is left to chance."""
    lexicon = Lexicon()
    words = Words(lexicon)
    tokens_of(texts, words)  # numbers all that is seen
    lexicon.growing = False
    if not texts or not any(spans):
        return Model(lexicon)
    tokens = tokens_of(texts, words)
    gold = gold_tags(tokens, texts, spans)
    inner = np.flatnonzero(~tokens.bound())
    of = np.searchsorted(tokens.firsts, tokens.word[inner], side="right") - 1
    sizes = np.bincount(of, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    total = len(lexicon.shapes)
    counts = [total, len(lexicon.details), len(lexicon.heads), total, total, total, total**2, total**2, DISTANCES * COARSE, 2 * COARSE * COARSE, FILES * COARSE]
    emit, seen_e = [np.zeros((n, 3)) for n in counts], [np.full((n, 3), 1e-8) for n in counts]
    move, seen_m = np.zeros((3, 3)), np.full((3, 3), 1e-8)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    batches = []
    for i in range(0, len(order), 512):
        rows = order[i : i + 512]
        wide = sizes[rows].max()
        there = np.arange(wide)[None, :] < sizes[rows][:, None]
        at = np.where(there, starts[rows][:, None] + np.arange(wide)[None, :], 0)
        flat = inner[at[there]]
        # numbers of the features that the batch has, so that its gradient is as small as it is
        own = [np.unique(f[flat], return_inverse=True) for f in tokens.features]
        tags = gold[flat]
        padded = np.zeros(there.shape, np.int8)
        padded[there] = tags
        real = np.zeros((3, 3))
        np.add.at(real, (padded[:, :-1][there[:, 1:]], padded[:, 1:][there[:, 1:]]), 1)
        np.add.at(real, (np.zeros(len(rows), int), padded[:, 0]), 1)
        np.add.at(real, (padded[np.arange(len(rows)), sizes[rows] - 1], np.zeros(len(rows), int)), 1)
        batches.append((there, own, tags, real))
    for _ in range(epochs):
        for there, own, tags, real in batches:
            flat = sum(w[u][k] for w, (u, k) in zip(emit, own, strict=True))
            score = np.zeros((*there.shape, 3))
            score[there] = flat
            node, expected = marginals(score, move + blocked(), there)
            error = node[there]
            error[np.arange(len(tags)), tags] -= 1
            size = len(there)
            for w, seen, (u, k) in zip(emit, seen_e, own, strict=True):
                grad = np.stack([np.bincount(k, error[:, tag], len(u)) for tag in range(3)], axis=1) / size + penalty * w[u]
                seen[u] += grad**2
                w[u] -= step * grad / np.sqrt(seen[u])
            grad = (expected - real) / size + penalty * move
            seen_m += grad**2
            move -= step * grad / np.sqrt(seen_m)
    return Model(lexicon, [w.astype(np.float32) for w in emit], move + blocked(), LEANING)
